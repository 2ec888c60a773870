"""Byte-level BPE: exact encoding in linear time by automaton and backtracking, and decoding.

The bytes of a word, read as Latin-1, run through an Aho-Corasick automaton of all tokens.  From the longest match at a
position the encoder goes on as long as each new token may stand behind its left neighbour; a dead end gives up the
last token and tries the next shorter one, and is entered once.  A sequence in which every adjacent pair is its own BPE encoding is the encoding
of the whole, so this gives the same merges as the merge loop.  Whether a pair is compatible is memoised.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from acrelane.llm.common import arrow_map, col, map_texts

DEFAULT_RANKS = "byte_bpe_multi_50k.tiktoken"
#: Entries that a worker keeps of words that it has met, and as many older ones.
CACHE_WORDS = 200_000
#: Pairs of tokens whose compatibility a worker keeps.
KEPT_PAIRS = 2_000_000
#: A word of more bytes is encoded each time it comes and not kept.
CACHE_BYTES = 200
#: Marks that often end a word.
MARKS = ".,;:!?"
#: Between two characters that are not white space, a space always begins a match of the split pattern.
_SAFE = re.compile(r"(?<=\S) (?=\S)")


class _Spaces(Exception):
    """A space stands beside other white space, so the text must not be cut at every space."""


class _Memo(dict):
    """Results of make by key, for short keys.  When CACHE_WORDS are kept they become the old ones, of which those that still occur are taken over."""

    def __init__(self, make: Callable):
        self.make, self.old = make, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= CACHE_BYTES:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[key] = got
        return got


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def _joined(*parts: tuple[tuple[int, ...], str, bytes]) -> tuple[tuple[int, ...], str, bytes]:
    ids, decimal, data = zip(*parts)
    return tuple(chain.from_iterable(ids)), ",".join(decimal), b"".join(data)


class BytePairEncoder:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.words = regex.compile(pattern).findall
        #: Tokens that the merges of their own bytes give; the others never occur.
        own = {t for t, rank in ranks.items() if len(t) == 1 or self._merge(t) == [rank]}
        self.automaton = ahocorasick.Automaton()
        self.shorter: dict[int, int] = {}
        for token in own:
            self.automaton.add_word(token.decode("latin-1"), ranks[token])
            self.shorter[ranks[token]] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in own), -1)
        self.automaton.make_automaton()
        self.lengths = {rank: len(token) for token, rank in ranks.items()}
        self.reach = max(map(len, own))
        #: Memo of whether two tokens may stand side by side.
        self.pairs: dict[tuple[int, int], bool] = {}
        #: Ids of words; of pieces of a text the ids, their decimal text and the bytes that they decode to.
        self.known = _Memo(lambda word: tuple(self.encode_word(word.encode())))
        self.pieces = _Memo(self._piece)
        self.head = _Memo(lambda piece: self._common(self.head, "", piece))
        self.spaced = _Memo(lambda piece: self._common(self.spaced, " ", piece))
        self.marks = {mark: self._piece(mark) for mark in MARKS}

    def _merge(self, word: bytes) -> list[int]:
        """The defining merge loop; for single tokens and pairs of them only, hence short."""
        ranks, none = self.ranks, 1 << 60
        parts = [word[i : i + 1] for i in range(len(word))]
        costs = [ranks.get(x + y, none) for x, y in zip(parts, parts[1:])]
        while costs:
            best = min(costs)
            if best == none:
                break
            i = costs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                costs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def _fits(self, pair: tuple[int, int]) -> bool:
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        good = self.pairs[pair] = self._merge(self.tokens[pair[0]] + self.tokens[pair[1]]) == [*pair]
        return good

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one match of the split pattern."""
        text = word.decode("latin-1")
        greedy = [rank for _, rank in self.automaton.iter_long(text)]
        known = self.pairs
        for i, pair in enumerate(zip(greedy, greedy[1:])):
            good = known.get(pair)
            if good is None:
                good = self._fits(pair)
            if not good:
                return self._backtrack(text, greedy[: i + 1], greedy[i + 1])
        return greedy

    def _longest(self, text: str, at: int) -> int:
        return next(self.automaton.iter_long(text[at : at + self.reach]))[1]

    def _backtrack(self, text: str, out: list[int], token: int) -> list[int]:
        """Goes on behind the good tokens out, before token: from the longest match at each position to shorter tokens, then to other left neighbours."""
        n, lengths, shorter, known = len(text), self.lengths, self.shorter, self.pairs
        dead = bytearray(n + 1)
        at, last = sum(lengths[t] for t in out), out[-1]
        while True:
            end = at + lengths[token]
            good = not dead[end]
            if good and last >= 0:
                good = known.get((last, token))
                if good is None:
                    good = self._fits((last, token))
            if good:
                out.append(token)
                if end == n:
                    return out
                at, last, token = end, token, self._longest(text, end)
                continue
            token = shorter[token]
            while token < 0:  # nothing fits here behind the last token
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                dead[at] = 1
                gone = out.pop()
                at -= lengths[gone]
                token, last = shorter[gone], out[-1] if out else -1

    @staticmethod
    def _sound(piece: str) -> str:
        """piece, if it has no white space at an end."""
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Spaces
        return piece

    def _piece(self, piece: str) -> tuple[tuple[int, ...], str, bytes]:
        return self._entry(tuple(chain.from_iterable(map(self.known.__getitem__, self.words(piece)))))

    def _entry(self, ids: tuple[int, ...]) -> tuple[tuple[int, ...], str, bytes]:
        return ids, ",".join(map(str, ids)), self.decode(ids)

    def _common(self, memo: _Memo, before: str, piece: str) -> tuple[tuple[int, ...], str, bytes]:
        """A piece, which stands behind before, by its parts: letters are one match, and so is a mark behind them."""
        if piece.isalpha():
            return self._entry(tuple(self.encode_word((before + piece).encode())))
        mark = self.marks.get(piece[-1:])
        if mark and piece[:-1].isalpha():
            return _joined(memo[piece[:-1]], mark)
        return self._piece(before + self._sound(piece))

    def _parts(self, text: str) -> list[tuple[tuple[int, ...], str, bytes]]:
        """The text's pieces, encoded.  A space between two characters that are not white space begins a match, so texts are cut there."""
        first, *others = text.split(" ")
        try:
            return [self.head[first], *map(self.spaced.__getitem__, others)]
        except _Spaces:
            first, *others = _SAFE.split(text)
            return [self.pieces[piece] for piece in (first, *(" " + p for p in others)) if piece]

    def encode(self, text: str) -> list[int]:
        """Ids of a text."""
        return [i for ids, _, _ in self._parts(text) for i in ids]

    def round_trip(self, text: str) -> tuple[int, str, bytes]:
        """Number of ids, the ids in decimal joined by commas, and the bytes that they decode to."""
        parts = self._parts(text)
        if not parts:
            return 0, "", b""
        ids, decimal, data = zip(*parts)
        return sum(map(len, ids)), ",".join(decimal), b"".join(data)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str = public_tokenizers.PATTERN) -> BytePairEncoder:
    """One encoder a worker process and file."""
    return BytePairEncoder(read_ranks(path), pattern)


def _path(ranks: str) -> str:
    return ranks if "/" in ranks else public_tokenizers.path(ranks)


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """(id, ids array<int>) of every whole text.

    A null text counts as empty and gives an empty array; repeated rows give repeated rows; an empty table gives none; other
    columns are not carried.  Very long texts are encoded whole.
    """
    def fn(texts: list) -> dict:
        bpe = encoder(_path(ranks))
        return {"ids": pa.array([bpe.encode(t or "") for t in texts], pa.list_(pa.int32()))}

    return map_texts(df, [(id_col, col(id_col))], col(text_col), fn, "ids array<int>")


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """(id, bytes binary) of every array of ids; null gives empty bytes; an id that the file lacks is an error."""
    kind = df.select(col(id_col)).schema[0].dataType.simpleString()

    def run(batches):
        bpe = encoder(_path(ranks))
        for batch in batches:
            data = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["k0", "bytes"])

    return arrow_map(df.select(col(id_col).alias("k0"), col(ids_col).alias("ids")), run, f"k0 {kind}, bytes binary").toDF(id_col, "bytes")


def round_trip_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = DEFAULT_RANKS, with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes every whole text and decodes the ids in one pass; on demand the ids too.

    Defined as encode_texts for nulls, empty and repeated rows.
    """
    def fn(texts: list) -> dict:
        bpe = encoder(_path(ranks))
        counts, ids_sha, text_sha, all_ids = [], [], [], []
        for text in texts:
            n, decimal, data = bpe.round_trip(text or "")
            if with_ids:
                all_ids.append(np.array(decimal.split(",") if n else [], np.int32))
            counts.append(n)
            ids_sha.append(hashlib.sha256(decimal.encode()).hexdigest())
            text_sha.append(hashlib.sha256(data).hexdigest())
        return {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())} | ({"ids": pa.array(all_ids, pa.list_(pa.int32()))} if with_ids else {})

    return map_texts(df, [(id_col, col(id_col))], col(text_col), fn, "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""))
